"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstframe.llm import confusables, language, packing, pii, terms, tokenizer, truncation
from burstframe.session import table


def _identified(spark: SparkSession, d: str, words: bool) -> DataFrame:
    records = language.tweet_and_document_texts(table(spark, d, "raw_tweet"), table(spark, d, "documents"))
    return language.identify(records, language.train(table(spark, d, "corpus_item")), words)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_identified(spark, d, words=False))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of every record; one without a language has one row without."""
    rows = _identified(spark, d, words=True).dropDuplicates(["src", "rec_id"])
    rows = rows.select("src", "rec_id", "label_lang", F.posexplode_outer("segments").alias("segment", "s"))
    return rows.select("src", "rec_id", "label_lang", "segment", "s.lang", F.round("s.confidence", 6).alias("confidence"), "s.words")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return confusables.tweet_values(table(spark, d, "raw_tweet"), table(spark, d, "user_profile"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.lookalike_pairs(_values(spark, d))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return confusables.consistent_form(_values(spark, d).distinct(), "value", "form")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return confusables.lookalike_classes(_values(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return terms.tweet_records(table(spark, d, "raw_tweet"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(_records(spark, d)).where("mark IS NOT NULL").select("field", "term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(_records(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "probe_tweet").select(F.col("tweet_id").alias("id"))
    return terms.most_distinctive(terms.term_scores(terms.term_fields(_records(spark, d)), asked)).select(F.col("id").alias("tweet_id"), "term")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = terms.term_scores(terms.term_fields(_records(spark, d)))
    return scores.select(F.col("id").alias("tweet_id"), "term", "tf", "n_occurrences", "n_records", F.round("z", 6).alias("z"))


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, pii.Names, DataFrame | None]:
    users = table(spark, d, "user_profile")
    names, surnames = pii.learn_names(users, table(spark, d, "given_names"), table(spark, d, "corpus_item"))
    return pii.tweet_and_profile_texts(table(spark, d, "raw_tweet"), users), names, surnames


def _key(spark: SparkSession) -> bytes:
    """The key of the surrogates: what the session names, or one of this run only."""
    named = spark.conf.get("spark.burstframe.surrogateKey", "")
    return named.encode() if named else secrets.token_bytes(32)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts, names, surnames = _personal(spark, d)
    return pii.entity_rows(pii.replacements(pii.find_entities(texts, names, surnames), names, _key(spark)))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every tweet and profile, also those without personal data and those without a text."""
    texts, names, surnames = _personal(spark, d)
    return pii.redact(texts, names, _key(spark), surnames)


def _vocabulary(spark: SparkSession) -> str:
    return spark.conf.get("spark.burstframe.vocabulary", tokenizer.DEFAULT_VOCABULARY)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"), "doc_id", "text", _vocabulary(spark))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts, decoded from their ids."""
    return tokenizer.decoded(p7_ids(spark, d), "doc_id", "ids", _vocabulary(spark))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")  # counted by the files' footers
    return packing.containers(tokenizer.token_counts(documents, "doc_id", "text", _vocabulary(spark)), "doc_id", documents.count())


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_documents(table(spark, d, "documents"))


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_sources(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_segments, p2_found, p2_forms, p2_classes, p3_found, p3_terms, p4_found, p4_scores, p6_found, p6_redacted,
        p7_ids, p7_texts, p8_containers, p8_report, p9_found, p9_sources,
    )
}

_PUNCTUATION = terms.PUNCTUATION.replace("'", "''")
_RECORDS = """records AS (
    SELECT id_str, max(text) AS text, max(list_transform(entities.hashtags, lambda h: h.text)) AS tags
    FROM raw_tweet WHERE id_str IS NOT NULL GROUP BY id_str)"""
_TEXT_TERMS = f"list_filter(list_transform(regexp_split_to_array(lower(text), '[ \\t\\n\\r]'), lambda p: trim(p, '{_PUNCTUATION}')), lambda p: p <> '')"
_FIELDS = f"""{_RECORDS}, fields AS (
    SELECT id_str AS id, 'text' AS field, {_TEXT_TERMS} AS terms FROM records WHERE text IS NOT NULL
    UNION ALL
    SELECT id_str, 'hashtags', tags FROM (
        SELECT id_str, list_transform(list_filter(tags, lambda t: t IS NOT NULL AND t <> ''), lambda t: lower(t)) AS tags FROM records WHERE tags IS NOT NULL
    ) WHERE len(tags) > 0),
occurrences AS (SELECT id, field, unnest(terms) AS term FROM fields),
counts AS (SELECT field, term, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM occurrences GROUP BY field, term),
totals AS (SELECT field, count(*) AS total FROM fields GROUP BY field),
marks AS (
    SELECT *, n_records <= {terms.RARE_RECORDS} AS rare, n_records >= {terms.COMMON_SHARE} * total AS common
    FROM counts JOIN totals USING (field))"""
_MARKED = """SELECT field, term, 'rare' AS mark FROM marks WHERE rare UNION ALL SELECT field, term, 'common' FROM marks WHERE common"""
# The published formula (log-odds ratio with an informative Dirichlet prior): y are occurrences in the record (1) and in the
# rest (2), n their sums, a the prior, which is in proportion to the collection's occurrences.
_SCORES = f"""WITH {_FIELDS},
words AS (SELECT term, n_occurrences, n_records FROM counts WHERE field = 'text'),
record AS (SELECT id, term, count(*) AS y FROM occurrences WHERE field = 'text' GROUP BY id, term),
sizes AS (SELECT id, sum(y) AS n FROM record GROUP BY id),
both_sides AS (
    SELECT id, term, y AS y1, n AS n1, n_occurrences, n_records, n_occurrences - y AS y2, (SELECT sum(n_occurrences) FROM words) - n AS n2,
           {terms.PRIOR_WEIGHT}::DOUBLE * n_occurrences AS a, {terms.PRIOR_WEIGHT}::DOUBLE * (SELECT sum(n_occurrences) FROM words) AS a0
    FROM record JOIN sizes USING (id) JOIN words USING (term)),
scored AS (
    SELECT id, term, y1 AS tf, n_occurrences, n_records,
           (ln((y1 + a) / (n1 + a0 - y1 - a)) - ln((y2 + a) / (n2 + a0 - y2 - a))) / sqrt(1 / (y1 + a) + 1 / (y2 + a)) AS z
    FROM both_sides)"""

ORACLE: dict[str, str] = {
    "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_found": f"WITH {_FIELDS} {_MARKED}",
    "p3_terms": f"""WITH {_FIELDS} SELECT field, term, n_occurrences, n_records, m.mark
        FROM marks LEFT JOIN ({_MARKED}) m USING (field, term)""",
    "p4_scores": f"{_SCORES} SELECT id AS tweet_id, term, tf::INT AS tf, n_occurrences, n_records, round(z, 6) AS z FROM scored",
    "p4_found": f"""{_SCORES} SELECT id AS tweet_id, arg_min(term, [row(-z, term)]) AS term
        FROM scored WHERE id IN (SELECT tweet_id FROM probe_tweet) GROUP BY id""",
}
